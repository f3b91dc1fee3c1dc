"""formspark.streaming"""
