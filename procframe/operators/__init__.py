"""operators of the procframe engine."""
