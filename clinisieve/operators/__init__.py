"""Rules, joins, features, outliers, analytics and change tracking."""
