"""Finding personal and sensitive identifiers in text, as Spark jobs."""

from veilscan.operators.scan import findings_of, scan, scan_long_texts, scan_rows
from veilscan.params import ScanParams
from veilscan.rules import Rule

__all__ = ["Rule", "ScanParams", "findings_of", "scan", "scan_long_texts", "scan_rows"]
