"""resiq: peptide analytics and sequence data processing as Spark DataFrame operators."""
