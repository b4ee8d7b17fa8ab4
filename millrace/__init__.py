"""millrace: a retrieval, condensing and data-preparation engine on PySpark."""
