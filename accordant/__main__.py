import sys

from accordant.cli import main

sys.exit(main())
