import sys

from lodestrata.cli import main

sys.exit(main())
