"""lokalis: geographically weighted analytics expressed as Spark DataFrame plans."""
