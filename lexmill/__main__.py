import sys

from lexmill.cli import main

sys.exit(main())
