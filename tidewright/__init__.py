"""Market-signal, portfolio and corpus operators expressed as Spark DataFrame plans."""
