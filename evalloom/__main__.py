import sys

from evalloom.cli import main

sys.exit(main())
