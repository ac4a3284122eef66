import sys

from tablewright.cli import main

sys.exit(main())
