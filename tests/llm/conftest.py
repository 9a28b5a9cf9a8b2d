import os
import sys

# Tests here import from one another by plain names; last, so that tests of equal names one folder up come first.
sys.path.append(os.path.dirname(os.path.abspath(__file__)))
