"""SQL building blocks that Spark SQL and ANSI engines spell differently."""
