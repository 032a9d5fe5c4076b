"""recordloom: a Spark-native engine that turns messy tabular exports into merged, versioned records."""
