import os
import sys
from pathlib import Path

ROOT = str(Path(__file__).parent)
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, os.environ.get("PYTHONPATH", "")) if x)  # for the Python workers
