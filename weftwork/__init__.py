"""weftwork: log, text, graph and table analytics as lazy Spark DataFrame operators."""
