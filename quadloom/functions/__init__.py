"""quadloom.functions"""
