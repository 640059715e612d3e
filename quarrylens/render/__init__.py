"""Reports, sites and diagrams written from an analysis."""
