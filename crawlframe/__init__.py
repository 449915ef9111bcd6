"""Link-graph crawling and corpus preparation on Spark."""
