"""The library's logger; LOG_LEVEL=debug shows more."""

from __future__ import annotations

import logging
import os

logger = logging.getLogger("quillon")
logger.setLevel(logging.DEBUG if os.environ.get("LOG_LEVEL", "").lower() == "debug" else logging.INFO)
