"""K-mer count matrices and their statistics as Spark jobs."""
