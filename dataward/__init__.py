"""Governance analytics for shared data catalogues, as DataFrame-to-DataFrame operators."""
