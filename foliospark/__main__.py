import sys

from foliospark.cli import main

sys.exit(main(sys.argv[1:]))
