from .banding import ALERT_POLICY, DIAL_POLICY, REVIEW_POLICY, BandPolicy, decision, risk_band
from .cleaning import MISSING_TOKENS, blank_to_null, is_bad_number, nan_to_null, to_number, token_to_null
from .hashing import key_bucket, key_digest, key_hash
from .vectors import separate_vector, vector_element

__all__ = [
    "ALERT_POLICY", "DIAL_POLICY", "REVIEW_POLICY", "BandPolicy", "decision", "risk_band",
    "MISSING_TOKENS", "blank_to_null", "is_bad_number", "nan_to_null", "to_number", "token_to_null",
    "key_bucket", "key_digest", "key_hash", "separate_vector", "vector_element",
]
