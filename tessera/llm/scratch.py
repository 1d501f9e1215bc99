"""Tables written to the cluster's shared folder to cut lineage; see ``tessera.store``."""

from __future__ import annotations

from tessera.store import drop, sent, size  # noqa: F401
from tessera.store import written as table  # noqa: F401
