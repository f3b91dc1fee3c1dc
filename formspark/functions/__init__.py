"""formspark.functions"""
