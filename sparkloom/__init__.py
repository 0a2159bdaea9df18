"""sparkloom: code-dependency and data-access analytics as Spark jobs."""
