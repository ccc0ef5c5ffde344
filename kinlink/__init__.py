"""Entity resolution over business records, written as Spark DataFrame plans."""
