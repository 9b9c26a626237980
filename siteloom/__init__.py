"""Analytics of crawls, access logs, link graphs and page audits on Spark."""
