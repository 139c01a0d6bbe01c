"""loanlens: credit-application analytics as Spark DataFrame and Spark ML jobs."""
