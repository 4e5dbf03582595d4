"""loomgraph: a Spark-native engine for link graphs and text corpora."""
