import sys

from keyfathom.cli import main

sys.exit(main())
