"""formspark.operators"""
