import sys

from nearfield.sources.inspect import main

sys.exit(main())
