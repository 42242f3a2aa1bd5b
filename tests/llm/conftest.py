import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent.parent
for folder in (ROOT, ROOT / "tests"):
    sys.path.insert(0, str(folder))
