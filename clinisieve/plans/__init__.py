"""Whole validations, composed of rules, cross checks and outliers."""
