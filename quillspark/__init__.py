"""quillspark: DataFrame operators for studying the writing of funding campaigns."""

__version__ = "0.1.0"
