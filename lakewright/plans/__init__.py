"""Query plans; importing this package registers every named query."""

from . import registry, relational, textual  # noqa: F401
