"""streaming of the procframe engine."""
