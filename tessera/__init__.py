"""tessera: a DataFrame-first analytics engine on Spark."""
