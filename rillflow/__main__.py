import sys

from rillflow.plans.flow import main

sys.exit(main())
