import sys

from .plans.runs import main

sys.exit(main())
