"""Document classification and routing over tables of document nodes, on Spark."""
