"""Field scans, stored versions and result tables."""
