"""formspark.sources"""
