"""Whole jobs: declared specs, the prebuilt analytics and the record-keeping reports."""
