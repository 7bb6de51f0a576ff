"""plans of the procframe engine."""
