"""Set-based answers to place-record questions, written as Spark DataFrame jobs."""
