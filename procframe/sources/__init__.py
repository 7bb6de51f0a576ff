"""sources of the procframe engine."""
