"""Spark-native operators for choosing, describing and auditing small representative subsets of
labelled data, and for analysing the experiments run on them."""
