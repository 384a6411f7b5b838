"""Document-dataset engine on Spark: text clean-up, page assembly, alignment and evaluation as DataFrame operators."""

__version__ = "0.1.0"
