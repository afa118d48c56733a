"""tablecraft: preparing and analysing messy tables with Spark DataFrames."""
