"""Real-time and historical market intelligence over marketplace listings and sales."""

from marketpulse.schemas import Thresholds, ValidationLimits
from marketpulse.session import build_session

__all__ = ["Thresholds", "ValidationLimits", "build_session"]
