"""Query registries and the driver loops that string operators together."""
