"""Training-data operators: filters, joins, scores, mixing and packing over document tables."""
