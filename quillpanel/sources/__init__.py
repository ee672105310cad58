"""Panels, market-data scans, upserts and quality flags."""
