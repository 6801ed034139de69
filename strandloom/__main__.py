import sys

from strandloom.plans.aligner import main

sys.exit(main(sys.argv[1:]))
