from .scoring import read_stream, score_stream
from .validation import merged_report, tally_stream

__all__ = ["merged_report", "read_stream", "score_stream", "tally_stream"]
