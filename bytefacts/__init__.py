"""bytefacts: Spark-first analytics over facts decoded from bytecode artifacts."""
