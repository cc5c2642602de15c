"""DataFrame operators: ordering, joins, aggregates, feature jobs, priorities, reports."""
