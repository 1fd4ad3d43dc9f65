"""Spark-native document analytics: plans over DataFrames that Catalyst optimises."""
