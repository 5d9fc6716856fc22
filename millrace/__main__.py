import sys

from millrace.programs import main

sys.exit(main(sys.argv[1:]))
