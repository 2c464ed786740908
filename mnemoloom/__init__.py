"""Table-in/table-out Spark operators for conversational-memory analytics and training-data pipelines."""
