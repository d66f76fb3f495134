"""Scheduled refresh: land the register, stage it, build and export every table.

spark-submit --py-files tenderlake.zip refresh.py --register PATH --groups CSV --out DIR
"""

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tenderlake.plans.job import main  # noqa: E402

if __name__ == "__main__":
    main()
