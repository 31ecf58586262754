"""tideline: credit-network analytics and corpus preparation as PySpark DataFrame jobs."""
