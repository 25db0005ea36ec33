import sys

from querylens.cli import main

sys.exit(main())
