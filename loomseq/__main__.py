"""``python -m loomseq``."""

import sys

from loomseq.cli import main

sys.exit(main())
