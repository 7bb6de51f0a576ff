"""functions of the procframe engine."""
