"""Registered queries; the registry comes first, as it imports the modules that register with it."""

from agrolith.plans import registry  # noqa: F401
