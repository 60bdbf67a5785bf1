"""quern: scientific and corpus analytics expressed as Spark DataFrame plans."""
