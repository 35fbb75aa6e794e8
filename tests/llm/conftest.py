import os
import sys

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SF001 = "/root/testdata/sf0.001"  # whichever conftest is imported by name has it
