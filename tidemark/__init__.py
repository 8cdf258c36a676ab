"""Market-feed analytics on PySpark: feeds in, consensus, decisions and audits out."""
