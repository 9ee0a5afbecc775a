"""quadloom.plans"""
