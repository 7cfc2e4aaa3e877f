"""quillspark: experiment-ledger analytics as PySpark DataFrame operators."""
