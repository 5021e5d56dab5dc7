"""evoframe package."""
