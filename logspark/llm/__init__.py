"""Operators for preparing training data: de-duplication, filtering, mixing, scoring, search and archives.

Nothing else in the library imports this package. Its functions travel inside the tasks.
"""

import sys

from logspark.session import send_code_of

send_code_of(sys.modules[__name__])
