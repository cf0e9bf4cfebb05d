"""demandlens: skill-demand analytics and job-market data preparation on Spark DataFrames."""
