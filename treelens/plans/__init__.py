"""Whole plans: the scan of projects, its reports, and the registered queries."""
