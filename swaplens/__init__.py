"""swaplens: model-swap regression analysis over recorded LLM traffic, on Spark DataFrames."""

__version__ = "0.1.0"
