"""Panel, portfolio and text analytics expressed as Spark DataFrame operators."""
