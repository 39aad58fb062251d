"""Credit-risk feature and scoring jobs on Spark."""
